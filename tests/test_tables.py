"""Sinks, readers and streams."""

import datetime
import json

from pyspark.sql import functions as F

from storytide.sources import readers
from storytide.sources.sinks import Table, difference
from storytide.streaming import streams


def test_table(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", "k int, v string, day date")
    d = datetime.date(2024, 1, 1)
    rows = spark.createDataFrame([(1, "a", d), (2, "b", d)], t.schema)
    assert t.insert_ignore(rows, ["k"]) == 2 and t.insert_ignore(rows, ["k"]) == 0
    assert t.upsert(spark.createDataFrame([(2, "c", d), (3, None, d)], t.schema), ["k"]) == 2
    assert t.upsert(spark.createDataFrame([(2, "c", d), (3, None, d)], t.schema), ["k"]) == 0
    assert sorted((r.k, r.v) for r in t.read().collect()) == [(1, "a"), (2, "c"), (3, None)]
    assert t.delete_obsolete(spark.createDataFrame([(1,)], "k int"), ["k"], "day", "2024-01-01", "2024-01-02") == 2
    t.replace_days(spark.createDataFrame([(9, "z", datetime.date(2024, 1, 5))], t.schema), "day", ["2024-01-05"])
    assert t.prune("day", "2024-01-02") == 1 and [r.k for r in t.read().collect()] == [9]


def test_difference(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1, "a"), (2, "x"), (4, "n")], "k int, v string")
    assert {r.k: r.action for r in difference(a, b, ["k"]).collect()} == {1: "keep", 2: "update", 3: "delete", 4: "insert"}


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A</title><link>http://x/a</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate><description>&lt;p&gt;Body&lt;/p&gt;</description></item><item><title></title><link>http://x/b</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate><description>x</description></item><item><title>Old</title><link>http://x/c</link><pubDate>Fri, 01 Dec 2023 10:00:00 +0000</pubDate><description>x</description></item></channel></rss>")
    got = readers.feed(spark, str(tmp_path / "f.xml"), "2024-01-02 00:00:00").collect()
    assert [(r.title, r.text) for r in got] == [("A", "Body")]


def test_atom_and_rdf(spark, tmp_path):
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Atom one</title><link rel="self" href="http://x/self"/><link href="http://x/atom"/><updated>2024-01-01T11:00:00Z</updated><id>a1</id><content type="html">&lt;b&gt;Body&lt;/b&gt; of it</content></entry></feed>"""
    rdf = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns="http://purl.org/rss/1.0/"><item rdf:about="http://x/rdf"><title>RDF one</title><link>http://x/rdf</link><dc:date>2024-01-01T09:00:00Z</dc:date><description>text</description></item></rdf:RDF>"""
    for name, text in (("a.xml", atom), ("r.xml", rdf)):
        (tmp_path / "feeds").mkdir(exist_ok=True)
        (tmp_path / "feeds" / name).write_text(text)
    got = readers.feed(spark, str(tmp_path / "feeds"), "2024-01-02 00:00:00").collect()
    assert [(r.title, r.url, r.text) for r in got] == [("Atom one", "http://x/atom", "Body of it"), ("RDF one", "http://x/rdf", "text")]


def test_discovery(spark, tmp_path):
    a = [
        {"url": " http://www.a.test/1 ", "title": "One", "seendate": "20240131T120000Z", "domain": ""},
        {"url": "", "url_mobile": "http://m.b.test/2", "title": "Two", "seendate": "20240131T130000Z", "domain": "b.test"},
        {"url": "http://c.test", "title": " ", "seendate": "20240131T130000Z"},
        {"url": "http://d.test", "title": "No date", "seendate": "soon"},
        {"url": "http://www.a.test/1", "title": "One again", "seendate": "20240130T120000Z"},
    ]
    (tmp_path / "g.json").write_text(json.dumps({"articles": a}))
    got = sorted(readers.discovered(spark, str(tmp_path / "g.json")).collect(), key=lambda r: r.title)
    assert [(r.title, r.publisher, r.url, r.retention, str(r.published)) for r in got] == [("One", "a.test", "http://www.a.test/1", "metadata_only", "2024-01-31 12:00:00"), ("Two", "b.test", "http://m.b.test/2", "metadata_only", "2024-01-31 13:00:00")]
    assert readers.discovery_query("markets", []) == "markets" and readers.discovery_query("q", ["a", "b"]) == "q (domain:a OR domain:b)"


def test_article_search(spark, tmp_path):
    doc = lambda url, title, abstract, snippet="": {"web_url": url, "headline": {"main": title}, "abstract": abstract, "snippet": snippet, "pub_date": "2024-01-31T12:00:00+0000"}
    pages = [{"page": 0, "response": {"docs": [doc("http://n/1", "One", "Abstract"), doc("http://n/2", "Two", "", "Snippet"), doc("http://n/3", "Empty", "")]}}, {"page": 1, "response": {"docs": [doc("http://n/1", "One", "Abstract"), doc("http://n/4", "Four", "x")]}}]
    (tmp_path / "pages").mkdir()
    for k, p in enumerate(pages):
        (tmp_path / "pages" / f"{k}.json").write_text(json.dumps(p))
    got = lambda n: sorted((r.title, r.text) for r in readers.searched(spark, str(tmp_path / "pages"), n).collect())
    assert got(1) == [("One", "Abstract"), ("Two", "Snippet")] and got(5) == [("Four", "x"), ("One", "Abstract"), ("Two", "Snippet")]


def test_market_news_and_transcripts(spark, tmp_path):
    items = [{"symbol": "A", "publishedDate": "2024-01-31 12:00:00", "title": "T", "text": "body", "site": "s.test", "url": "http://s.test/1"}, {"symbol": "B", "publishedDate": "2024-01-31 11:00:00", "title": "T", "text": "", "url": "http://s.test/1"}, {"symbol": "A", "publishedDate": "2024-01-01 12:00:00", "title": "Old", "text": "x", "url": "http://s.test/2"}]
    (tmp_path / "n.json").write_text("\n".join(map(json.dumps, items)))
    assert [(r.title, r.text, r.publisher) for r in readers.market_news(spark, str(tmp_path / "n.json"), "2024-02-01 00:00:00").collect()] == [("T", "body", "s.test")]
    (tmp_path / "t.json").write_text("\n".join(json.dumps({"ticker": "A", "year": 2023 + k // 4, "quarter": k % 4 + 1, "date": "", "content": f"c{k}"}) for k in range(10)))
    assert sorted(r.content for r in readers.transcripts(spark, str(tmp_path / "t.json"), 3).collect()) == ["c7", "c8", "c9"]


def test_connectors_and_archives(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    row = lambda i, url: (i, "s", "newspaper", "T", "p", url, at, "x", "snippet")
    both = readers.poll_all(spark, [readers.manual("one", [row("a", "u1"), row("b", "u2")]), readers.manual("two", [row("c", "u1"), row("d", "u3")])])
    assert sorted((r.document_id, r.connector_id) for r in both.collect()) == [("a", "one"), ("b", "one"), ("d", "two")]
    assert readers.poll_all(spark, []).count() == 0
    posts = spark.createDataFrame([(f"u{k}", at + datetime.timedelta(days=k)) for k in range(5)], "url string, published timestamp")
    assert [r.url for r in readers.archive_since(posts, "2024-01-02 00:00:00", 2).collect()] == ["u4", "u3"] and readers.archive_since(posts, None, 9).count() == 5
    (tmp_path / "c.json").write_text('{"symbol":"abc","name":"N","sector":"S"}\n{"symbol":"ABC","name":"N","sector":"S"}')
    assert [r.ticker for r in readers.constituents(spark, str(tmp_path / "c.json")).collect()] == ["ABC"]
    none, some = spark.createDataFrame([], "ticker string"), spark.createDataFrame([(" x ",), ("X",), ("",)], "ticker string")
    assert [r.ticker for r in readers.universe(none, some, none).collect()] == ["X"] and readers.universe(none).count() == 0


def test_form_switches():
    off = dict.fromkeys(("core", "foreign", "proxy", "capital_markets", "ownership", "stress"), False)
    assert readers.enabled_forms(**off) == [] and readers.enabled_forms(**off | {"core": True}, current=False) == ["10-K", "10-Q"]
    assert readers.enabled_forms(**off | {"foreign": True, "stress": True})[:4] == list(readers.FOREIGN_STRESS) and "4" in readers.enabled_forms(structured_ownership=True) and "4" not in readers.enabled_forms()


def test_exhibits_and_export(spark, tmp_path):
    x = spark.createDataFrame([("EX-99.1", "a"), ("EX-10.1", "b"), ("EX-31", "cert"), ("EX-31", "Investor day")], "kind string, name string")
    assert [r[0] for r in x.select(readers.exhibit_relevance(F.col("kind"), F.col("name"))).collect()] == ["high", "medium", "low", "high"]
    from storytide.sources.sinks import export_json

    export_json(x, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4


def test_scratch_is_cleared(spark):
    import os

    from storytide import session

    x = session.written(spark.range(3), "numbers")
    path = x.inputFiles()[0].removeprefix("file:").replace("///", "/")
    assert x.count() == 3 and os.path.exists(path) and not path.startswith("/tmp/storytide")
    session.clear(spark)
    assert not os.path.exists(path)


def test_chains(spark):
    from storytide.operators.relational import resolve_chain

    x = spark.createDataFrame([(k, k + 1) for k in range(25)] + [(100, 101)], "s long, t long")
    for hops in (1, 2, 7, 16, 20, 30):
        got = {r.s: (r.t, r.steps) for r in resolve_chain(x, "s", "t", hops).collect()}
        assert got == {k: (min(25, k + hops), min(25 - k, hops)) for k in range(25)} | {100: (101, 1)}


def test_filings(spark, tmp_path):
    x = {"ticker": "T", "form": ["10-K", "8-K", "4"], "filingDate": ["2024-01-01", "2024-02-01", "2024-03-01"], "accessionNumber": ["1", "2", "3"], "primaryDocument": ["a", "b", "c"], "items": ["", "2.02", ""], "description": ["", "", ""]}
    (tmp_path / "s.json").write_text(json.dumps(x))
    got = readers.filings(spark, str(tmp_path / "s.json"), ["10-K", "8-K"], "2023-12-31", 1).collect()
    assert [(r.form, r.relevance) for r in got] == [("8-K", "high")]


def test_publications(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("publications:\n  - name: One\n    url: https://one.test\n  - name: Two\n    url: 'https://two.test'\n")
    got = [r.asDict() for r in readers.publications(spark, str(tmp_path / "p.yaml")).collect() if r["url"]]
    assert [(r["name"], r["url"]) for r in got] == [("One", "https://one.test"), ("Two", "https://two.test")]


def test_daily_counts_stream_equals_batch(spark, tmp_path):
    for k in range(3):
        spark.range(50).select(F.timestamp_seconds(F.col("id") * 7000 + k).alias("ts"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value")).write.parquet(str(tmp_path / "in" / f"p{k}"))
    src = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    src.write.parquet(str(tmp_path / "all"))
    s = streams.daily_counts(streams.parquet_stream(spark, str(tmp_path / "all")), "ts", "event_type")
    got = sorted(map(tuple, streams.drain(s, "t_daily", "complete").collect()))
    want = sorted(map(tuple, src.groupBy(F.to_date("ts").alias("date"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).collect()))
    assert got == want


def test_touched_days(spark, tmp_path):
    spark.createDataFrame([("2024-01-02",), ("2024-01-01",), ("2024-01-02",)], "d string").write.parquet(str(tmp_path / "in"))
    seen = []
    streams.touched_days(streams.parquet_stream(spark, str(tmp_path / "in"), 100), "d", lambda df, days: seen.append(days), str(tmp_path / "ck")).awaitTermination()
    assert sorted(d for x in seen for d in x) == ["2024-01-01", "2024-01-02"]


def test_titles_are_whole_first_lines(spark, tmp_path):
    """Titles beyond 200 characters: title_ngrams and folded_titles against a loop."""
    import hashlib
    import re
    import unicodedata
    from collections import Counter

    import storytide.queries  # noqa: F401  registers
    from storytide.functions import lists
    from storytide.queries.registry import QUERIES

    name = lambda k: "".join(chr(97 + k // 20**i % 20) for i in range(4))
    long = " ".join(name(k) for k in range(500, 1500))
    lines = [f"{long} first", f"{long} second", "½ " * 120 + "alpha", "½ " * 120 + "gamma", "... " * 60 + "delta epsilon", "... " * 60 + "zeta eta", "short title"]
    rows = [(k, f"{t}\nbody text of no title", "en", "s", len(t)) for k, t in enumerate(lines)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")

    def words(t):
        w = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9&%$.\- ]+", " ", t.lower())).strip().split(" ")
        return [x for x in w if len(x) > 1 and x not in lists.TITLE_STOPWORDS and not re.fullmatch(r"\d+(\.\d+)?%?", x)]

    grams = Counter(g for t in lines for g in {" ".join(words(t)[i : i + n]) for n in (2, 3) for i in range(len(words(t)) - n + 1)} if re.search("[a-z]{3,}", g))
    assert {r["gram"]: r["documents"] for r in QUERIES["title_ngrams"](spark, str(tmp_path)).collect()} == grams
    fold = lambda t: re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKD", t).lower()).strip()[:180]
    keys = Counter(hashlib.sha256(fold(t).encode()).hexdigest() for t in lines)
    assert {r["key"]: r["documents"] for r in QUERIES["folded_titles"](spark, str(tmp_path)).collect()} == keys
