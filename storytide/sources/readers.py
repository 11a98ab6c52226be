"""Connectors: each turns a payload into documents (document_id, source, source_class, title, publisher, url, published, text, retention)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.address import hostname, owner_of
from ..functions.jsondoc import bound
from ..functions.text import html_to_text
from ..operators.relational import top_per

DOCUMENT = "document_id string, source string, source_class string, title string, publisher string, url string, published timestamp, text string, retention string"
SNIPPET, SUMMARY = 2000, 500


@dataclass(frozen=True)
class Connector:
    """An id, a source class, and a function from a session to documents."""

    id: str
    source_class: str
    poll: Callable[[SparkSession], DataFrame]


def manual(id: str, rows: list[tuple], source_class: str = "manual") -> Connector:
    return Connector(id, source_class, lambda spark: spark.createDataFrame(rows, DOCUMENT))


def poll_all(spark: SparkSession, connectors: list[Connector]) -> DataFrame:
    """The documents of all connectors with the connector's id; the first of an address stays."""
    out = None
    for k, c in enumerate(connectors):
        rows = c.poll(spark).withColumn("connector_id", F.lit(c.id)).withColumn("__order", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], DOCUMENT + ", connector_id string")
    return top_per(out, ["url"], 1, F.asc("__order"), F.asc("document_id")).drop("__order")


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """file, document_id, title, url, stamp, html of the entries of RSS, RDF (item) and Atom (entry) files; an Atom link is an attribute."""
    common = "title string, pubDate string, date string, updated string, published string, description string, summary string, content string, encoded string, guid string, id string"
    xml = lambda tag, link: spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").schema(f"{common}, link {link}").load(path)
    both = xml("item", "string").unionByName(xml("entry", "array<struct<_href:string,_rel:string>>").withColumn("link", F.coalesce(F.get(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"], F.get("link", F.lit(0))["_href"])))
    url, text = F.trim("link"), F.coalesce("encoded", "content", "description", "summary")
    both = both.withColumn("file", F.input_file_name())
    return both.select("file", F.coalesce("guid", "id", url).alias("document_id"), F.trim("title").alias("title"), url.alias("url"), F.coalesce("pubDate", "published", "date", "updated").alias("stamp"), text.alias("html"))


def feed(spark: SparkSession, path: str, as_of: str, lookback_hours: int = 48, limit: int = 250, source: str = "rss", source_class: str = "newspaper", retention: str = "snippet") -> DataFrame:
    """RSS, RDF and Atom files, a feed each: entries with title, address, date and body within the lookback, the newest
    `limit` of each feed."""
    stamp = F.col("stamp")
    when = F.coalesce(F.try_to_timestamp(F.regexp_replace(stamp, r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(stamp))
    body = html_to_text(F.col("html"))
    rows = _entries(spark, path).select("file", "document_id", F.lit(source).alias("source"), F.lit(source_class).alias("source_class"), "title", F.lit(source).alias("publisher"), "url", when.alias("published"), F.when(F.lit(retention) == "snippet", F.substring(body, 1, SNIPPET)).otherwise(body).alias("text"), F.lit(retention).alias("retention"))
    end = F.to_timestamp(F.lit(as_of))
    kept = rows.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != "") & F.col("published").between(end - F.make_interval(hours=F.lit(lookback_hours)), end))
    return top_per(kept, ["file"], limit, F.desc("published"), F.asc("url"), F.asc("document_id")).drop("file")


def _documents(rows: DataFrame, source: str, retention: str, **columns: Column) -> DataFrame:
    """Rows with a title, an address and a date as documents, each address once, the newest of it."""
    own = {"document_id": F.concat(F.lit(f"{source}:"), F.substring(F.sha2("url", 256), 1, 24)), "source": F.lit(source), "source_class": F.lit("newspaper"), "retention": F.lit(retention)}
    x = rows.where((F.coalesce("url", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "") & F.col("published").isNotNull()).withColumns(own | columns)
    return top_per(x.select(*[f.split()[0] for f in DOCUMENT.split(", ")]), ["url"], 1, F.desc("published"), F.asc("title"))


def discovered(spark: SparkSession, path: str) -> DataFrame:
    """News discovery payloads {articles: [..]}: metadata only, the title stands for the text; dates as 20240131T120000Z."""
    schema = "articles array<struct<url:string,url_mobile:string,title:string,seendate:string,domain:string>>"
    a = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("articles").alias("a")).select("a.*")
    url = F.coalesce(F.nullif(F.trim("url"), F.lit("")), F.nullif(F.trim("url_mobile"), F.lit("")))
    when = F.try_to_timestamp(F.concat(F.regexp_replace("seendate", "Z$", ""), F.lit(" +0000")), F.lit("yyyyMMdd'T'HHmmss Z"))
    rows = a.select(url.alias("url"), F.trim("title").alias("title"), when.alias("published"), F.coalesce(F.nullif(F.trim("domain"), F.lit("")), hostname(url)).alias("publisher"))
    return _documents(rows.withColumn("text", F.col("title")), "gdelt-news", "metadata_only")


def discovery_query(query: str, domains: list[str]) -> str:
    """The search string: the query, and any of the domains if there are some."""
    return query if not domains else f"{query} ({' OR '.join(f'domain:{d}' for d in domains)})"


def searched(spark: SparkSession, path: str, pages: int = 5) -> DataFrame:
    """Article search payloads {response: {docs: [..]}}, a page each: abstracts, or snippets where they are missing."""
    schema = "page int, response struct<docs:array<struct<web_url:string,headline:struct<main:string>,abstract:string,snippet:string,pub_date:string,source:string>>>"
    x = spark.read.schema(schema).json(path, multiLine=True).where(F.coalesce("page", F.lit(0)) < min(5, max(1, pages))).select(F.explode("response.docs").alias("d")).select("d.*")
    body = F.trim(F.coalesce(F.nullif("abstract", F.lit("")), "snippet", F.lit("")))
    rows = x.select(F.trim("web_url").alias("url"), F.trim("headline.main").alias("title"), F.try_to_timestamp("pub_date").alias("published"), F.coalesce("source", F.lit("The New York Times")).alias("publisher"), body.alias("text"))
    return _documents(rows.where("text <> ''"), "nyt-search", "summary")


def market_news(spark: SparkSession, path: str, as_of: str, lookback_hours: int = 48) -> DataFrame:
    """News items (symbol, publishedDate, title, text, site, url) of tickers, or general ones, within the lookback."""
    x = spark.read.schema("symbol string, publishedDate string, title string, text string, site string, url string").json(path)
    end = F.to_timestamp(F.lit(as_of))
    rows = x.select(F.trim("url").alias("url"), F.trim("title").alias("title"), F.try_to_timestamp("publishedDate").alias("published"), F.coalesce("site", hostname(F.col("url"))).alias("publisher"), F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.col("title")).alias("text"))
    return _documents(rows.where(F.col("published") >= end - F.make_interval(hours=F.lit(lookback_hours))), "fmp-news", "snippet")


def filings(spark: SparkSession, path: str, forms: list[str], since: str, most: int) -> DataFrame:
    """Filings from JSON of parallel arrays (ticker, form[], filingDate[], accessionNumber[], primaryDocument[], items[], description[]): the enabled forms since a date, the newest of each ticker."""
    schema = "ticker string, form array<string>, filingDate array<string>, accessionNumber array<string>, primaryDocument array<string>, items array<string>, description array<string>"
    x = spark.read.schema(schema).json(path, multiLine=True)
    rows = x.select("ticker", F.inline(F.arrays_zip("form", "filingDate", "accessionNumber", "primaryDocument", "items", "description")))
    rows = rows.where(F.col("form").isin(forms) & (F.col("filingDate") >= since)).withColumn("relevance", relevance(F.col("form"), F.col("items"), F.col("description")))
    return top_per(rows, ["ticker"], most, F.desc("filingDate"), F.asc("accessionNumber"))


#: Forms of each kind, fixed values.
CORE = ("10-K", "10-Q", "8-K")
PERIODIC = ("10-K", "10-Q")
FOREIGN_REPORTS = ("20-F", "40-F", "6-K")
PROXY = ("DEF 14A", "DEFA14A", "PRE 14A")
CAPITAL_MARKETS = ("S-1", "S-1/A", "S-3", "S-3/A", "S-4", "S-4/A", "424B1", "424B2", "424B3", "424B4", "424B5")
FOREIGN_CAPITAL = ("F-1", "F-1/A", "F-3", "F-3/A", "F-4", "F-4/A")
OWNERSHIP = ("SC 13D", "SC 13D/A", "SC 13G", "SC 13G/A")
STRESS = ("NT 10-K", "NT 10-Q", "10-K/A", "10-Q/A", "8-K/A")
FOREIGN_STRESS = ("20-F/A", "40-F/A", "6-K/A", "NT 20-F")
STRUCTURED_OWNERSHIP = ("13F-HR", "4")
#: What filings of a category are read for; all other categories are formal disclosure.
USE_CASES = {"exhibit": "market_narrative", "proxy": "governance_political_regulatory", "capital_markets": "capital_markets_risk_appetite", "ownership": "activism_ownership_change", "stress": "accounting_operational_stress", "structured_ownership": "structured_positioning"}

_BY_CATEGORY = {"proxy": PROXY, "capital_markets": CAPITAL_MARKETS + FOREIGN_CAPITAL, "ownership": OWNERSHIP, "stress": STRESS + FOREIGN_STRESS, "structured_ownership": STRUCTURED_OWNERSHIP}


def enabled_forms(core: bool = True, current: bool = True, foreign: bool = True, proxy: bool = True, capital_markets: bool = True, ownership: bool = True, stress: bool = True, structured_ownership: bool = False) -> list[str]:
    """The forms to read. Foreign forms follow the switch of their domestic kind; `current` is for the 8-K among the core forms."""
    wanted = [
        (core, CORE if current else PERIODIC),
        (foreign and core, FOREIGN_REPORTS),
        (foreign and capital_markets, FOREIGN_CAPITAL),
        (foreign and stress, FOREIGN_STRESS),
        (proxy, PROXY),
        (capital_markets, CAPITAL_MARKETS),
        (ownership, OWNERSHIP),
        (stress, STRESS),
        (structured_ownership, STRUCTURED_OWNERSHIP),
    ]
    return [form for on, forms in wanted if on for form in forms]


def form_category(form: Column) -> Column:
    """proxy, capital_markets, ownership, stress, structured_ownership, or core for all other forms."""
    out = F.lit("core")
    for name, forms in _BY_CATEGORY.items():
        out = F.when(form.isin(*forms), name).otherwise(out)
    return out


def use_case(category: Column) -> Column:
    out = F.lit("formal_disclosure")
    for name, case in USE_CASES.items():
        out = F.when(category == name, case).otherwise(out)
    return out


def _holds(text: Column, signals: list[str]) -> Column:
    out = F.lit(False)
    for s in signals:
        out = out | text.contains(s)
    return out


def relevance(form: Column, items: Column, description: Column) -> Column:
    """high, medium or low: by the form where its kind decides, else by what items and description say."""
    text, category = F.lower(F.concat_ws(" ", F.coalesce(items, F.lit("")), F.coalesce(description, F.lit("")))), form_category(form)
    by_form = F.when(form.isin(*PERIODIC, *FOREIGN_REPORTS) | (category == "stress"), "high").when(category.isin("proxy", "capital_markets", "ownership"), "medium")
    return by_form.when(_holds(text, lists.HIGH_SIGNALS), "high").when(_holds(text, lists.MEDIUM_SIGNALS), "medium").otherwise("low")


def exhibit_relevance(kind: Column, name: Column) -> Column:
    text = F.lower(F.concat_ws(" ", kind, name))
    return F.when(_holds(text, lists.EXHIBIT_HIGH), "high").when(_holds(text, lists.EXHIBIT_MEDIUM), "medium").otherwise("low")


def exhibit_type(declared: Column, name: Column) -> Column:
    """The exhibit form that a filing's index declares, else the one that the file's name tells, else the name."""
    own = F.regexp_replace(F.upper(F.coalesce(declared, F.lit(""))), r"\s+", "")
    low = F.lower(name)
    which = F.regexp_extract(low, r"ex(?:hibit)?[-_]?99(?:[._-]?([12]))?", 1)
    by_name = F.when(low.rlike(r"ex(?:hibit)?[-_]?99"), F.when(which != "", F.concat(F.lit("EX-99."), which)).otherwise("EX-99")).when(_holds(low, ["ex10", "ex-10"]), "EX-10").when(_holds(low, ["ex2", "ex-2"]), "EX-2").otherwise(name)
    return F.when(own.rlike(r"^EX-\d"), own).otherwise(by_name)


#: The forms whose exhibits are read, fixed values.
EXHIBIT_FORMS = ("8-K", "6-K")


def exhibits(files: DataFrame, forms: tuple[str, ...] = EXHIBIT_FORMS) -> DataFrame:
    """The files of filings that are exhibits to read, with exhibit_type and relevance. files: name, type (as the index has
    it), primary (the filing's own document), optionally form (only those of `forms` are read), and what else there is."""
    if "form" in files.columns:
        files = files.where(F.col("form").isin(*forms))
    kind, low = exhibit_type(F.col("type"), F.col("name")), F.lower("name")
    read = F.lit(False)
    for end in lists.EXHIBIT_FILES:
        read = read | low.endswith(end)
    wanted = kind.isin(lists.EXHIBIT_TYPES) | _holds(low, lists.EXHIBIT_NAMES)
    rows = files.where(~F.col("name").eqNullSafe(F.col("primary")) & read & wanted)
    return rows.withColumn("exhibit_type", kind).withColumn("relevance", exhibit_relevance(F.col("exhibit_type"), F.col("name")))


def lookback_hours(last_published: Column, backfill_days: Column, as_of: str) -> Column:
    """How far back a feed is read: the days of its backfill at first, then the whole hours since its last post and six
    more, twelve at least."""
    hours = F.greatest(F.unix_micros(F.to_timestamp(F.lit(as_of))) - F.unix_micros(last_published), F.lit(0)) / 3_600e6
    return F.when(last_published.isNull(), backfill_days * 24).otherwise(F.greatest(F.ceil(hours) + 6, F.lit(12))).cast("int")


def registered(spark: SparkSession, path: str, feeds: DataFrame, as_of: str) -> DataFrame:
    """The documents of all registered feeds in one scan: each feed with its own lookback, cap, retention and owner.

    path: payloads below feed=<feed_id>/. feeds: feed_id, name, owner, retention, last_published, backfill_days,
    most; payloads of other feeds are left out. Entries need a title, an address, a body and a date in the lookback.
    """
    own = _entries(spark, path).withColumn("feed_id", F.regexp_extract("file", "/feed=([^/]+)/", 1)).join(feeds, "feed_id")
    stamp, end = F.col("stamp"), F.to_timestamp(F.lit(as_of))
    when = F.coalesce(F.try_to_timestamp(F.regexp_replace(stamp, r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(stamp))
    hours = lookback_hours(F.col("last_published"), F.col("backfill_days"), as_of)
    body = html_to_text(F.col("html"))
    rows = own.withColumns({"published": when, "text": F.when(F.col("retention") == "snippet", F.substring(body, 1, SNIPPET)).otherwise(body)})
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    kept = rows.where(has(F.col("title")) & has(F.col("url")) & has(F.col("text")) & F.col("published").between(end - F.make_interval(hours=hours), end))
    kept = top_per(kept, ["feed_id"], F.col("most"), F.desc("published"), F.asc("url"), F.asc("document_id"))
    return kept.select("document_id", F.col("feed_id").alias("source"), F.lit("newspaper").alias("source_class"), "title", F.col("name").alias("publisher"), "url", "published", "text", "retention", "owner")


def preset_feeds(presets: DataFrame, groups: DataFrame) -> DataFrame:
    """Registered feeds from a list of presets (id, group, name, url, homepage): the owner is the group's (groups: group,
    owner), else the one that address or name tell, else the first part of the homepage's host; snippets of a week."""
    slug_of = F.regexp_extract(hostname(F.col("homepage")), r"^([^.]+)", 1)
    known = owner_of(F.col("url"), F.col("name"), fallback=slug_of)
    x = presets.join(groups.select("group", F.nullif("owner", F.lit("")).alias("__owner")), "group", "left")
    return x.select(F.col("id").alias("feed_id"), "name", "url", F.coalesce("__owner", known).alias("owner"), F.lit("snippet").alias("retention"), F.lit(7).alias("backfill_days"), F.lit(50).alias("most"))


def filing_part(text: Column) -> Column:
    """What part of a filing a text is, by its first 50 000 characters; null if they name none."""

    def part(begin: Column) -> Column:
        out = F.lit(None).cast("string")
        for label, said in reversed(lists.FILING_PARTS):
            out = F.when(F.contains(begin, F.lit(said)), label).otherwise(out)
        return out

    return bound(F.lower(F.substring(text, 1, 50_000)), part)


def transcripts(spark: SparkSession, path: str, quarters: int = 8) -> DataFrame:
    """JSON transcripts (ticker, year, quarter, content): the newest quarters of each ticker."""
    x = spark.read.schema("ticker string, year int, quarter int, date string, content string").json(path)
    return top_per(x, ["ticker"], quarters, F.desc("year"), F.desc("quarter"))


def archive_since(posts: DataFrame, since: str | None, cap: int) -> DataFrame:
    """Posts newer than the stored watermark, newest first, at most `cap` of each publication (publisher, if there is
    such a column)."""
    rows = posts if since is None else posts.where(F.col("published") > F.to_timestamp(F.lit(since)))
    own = ["publisher"] if "publisher" in posts.columns else []
    return top_per(rows, own, cap, F.desc("published"), F.asc("url")) if own else rows.orderBy(F.desc("published"), "url").limit(cap)


def advance_watermark(stored: DataFrame, polled: DataFrame, key: str) -> DataFrame:
    """key, last_published: never earlier than it was."""
    new = polled.groupBy(key).agg(F.max("published").alias("__new"))
    return stored.join(new, key, "full_outer").select(key, F.greatest("last_published", "__new").alias("last_published"))


def universe(*parts: DataFrame) -> DataFrame:
    """Tickers of the first part that has any, upper-cased, each once."""
    for p in parts:
        if not p.isEmpty():
            return p.select(F.upper(F.trim("ticker")).alias("ticker")).where("ticker <> ''").distinct()
    return parts[-1].select(F.upper("ticker").alias("ticker")).limit(0)


def constituents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("symbol string, name string, sector string").json(path).select(F.upper("symbol").alias("ticker"), "name", "sector").dropDuplicates(["ticker"])


def publications(spark: SparkSession, path: str) -> DataFrame:
    """A list of publications in a simple YAML file: '- name: ..' entries with one 'key: value' a line."""
    text = spark.read.text(path, wholetext=True)
    entry = F.explode(F.filter(F.split("value", r"(?m)^\s*-\s+"), lambda e: F.trim(e) != ""))
    pairs = F.transform(F.regexp_extract_all(F.col("entry"), F.lit(r"(?m)^\s*([A-Za-z_]+\s*:\s*[^#\n]+)"), 1), lambda p: F.struct(F.trim(F.regexp_extract(p, r"^([A-Za-z_]+)", 1)), F.trim(F.regexp_replace(F.regexp_extract(p, r":\s*(.*)$", 1), "^['\"]|['\"]$", ""))))
    return text.select(entry.alias("entry")).select(F.map_from_entries(pairs).alias("m")).where(F.size("m") > 0).select(*[F.try_element_at("m", F.lit(k)).alias(k) for k in ("name", "url", "slug", "owner")])
